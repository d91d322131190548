"""Three-valued rule matching of profiles against constraint records.

Every condition is ``pass``, ``fail`` or ``unknown`` (labels, never NULL logic), in a fixed order.
`evaluate` takes one row per (query, candidate) with profile columns ``p_*`` and constraint columns
``c_*``; columns that a table lacks count as not stated.  All of it is one projection: no join, no
shuffle and no Python, so any number of queries and candidates goes through one pass.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from eligspark.functions.rules import DEPENDENT_WORDS, NEGATED, PRIOR_BENEFIT, in_range, marital_admitted, stages_admitted, usable
from eligspark.functions.text import compiled_apart, dot, fenced, is_priority
from eligspark.schemas import CASTES, CHECK, CONDITION, ON_BEHALF, RULES

#: Results of the decisive conditions by place, null where a condition is absent or doesn't decide.
DECIDING = "__deciding"
OCCUPATION_THRESHOLD, TOUCH_THRESHOLD, CLARIFY_SCORE, BENCHMARK_DISABILITY = 0.85, 0.48, 0.5, 40

PROFILE_COLUMNS = {
    "age": "int", "annual_income_inr": "bigint", "land_acres": "double", "caste_category": "string", "is_minority": "boolean", "disability_percent": "double", "gender": "string", "residence": "string",
    "marital_status": "string", "state": "string", "bpl_household": "boolean", "registered_construction_worker": "boolean", "occupation": "string", "education_class": "int", "education_stage": "string",
    "applying_for": "string", "family": "string", "prior_benefit_schemes": "array<string>", "facts": "array<string>", "income_basis": "string", "land_basis": "string", "occupation_similarity": "double",
}
CONSTRAINT_COLUMNS = {
    "age_min": "int", "age_max": "int", "income_cap": "bigint", "income_basis": "string", "land_min": "double", "land_max": "double", "class_min": "int", "class_max": "int", "stage": "string", "gender": "string",
    "category": "array<string>", "category_span": "string", "occupation": "array<string>", "occupation_span": "string", "residence": "string", "marital_status": "string", "level": "string", "state": "string",
    "bpl_household": "boolean", "requires_bocw": "boolean", "not_availing_other": "boolean", "citizen": "boolean", "requires_dependent": "boolean", "family_notes": "string", "residuals": "array<string>",
    "admitted_stages": "array<string>", "admitted_statuses": "array<string>", "multi_branch": "boolean", "missing": "boolean", "touches": "int", "spans": "map<string,string>",
}
#: Columns of JSON: a record's bounds, from keys to columns, and a profile's values.
BOUNDS = {
    "c_json_age": {"min": "c_age_min", "max": "c_age_max"}, "c_json_income": {"max_annual_inr": "c_income_cap", "basis": "c_income_basis"},
    "c_json_land": {"min_acres": "c_land_min", "max_acres": "c_land_max"}, "c_json_class": {"min_class": "c_class_min", "max_class": "c_class_max"},
}
SHOWN = ("age", "annual_income_inr", "land_acres", "education_class", "gender", "residence", "marital_status", "state", "bpl_household", "registered_construction_worker", "occupation")


# Why a stated value doesn't decide a condition.
ON_BEHALF_NOTE = "the person is asking on behalf of someone else; their own value does not decide this"
DEPENDENT_NOTE = "the scheme requires a dependent, so this may be the dependent's attribute"


def json_of(**parts: Column) -> Column:
    """A JSON object with its nulls."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]), {"ignoreNullFields": "false"})


def json_value(value: Column) -> Column:
    """A scalar or list as JSON; null stays null."""
    inside = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substring(inside, F.lit(2), F.length(inside) - 2))


def completed(pairs: DataFrame) -> DataFrame:
    """`pairs` with every profile and constraint column, null where it lacks one; confidence columns p_<field>_conf stay optional.

    Columns that are there are fenced: conditions use them many times over, whatever expressions made them.
    """
    pairs = stated(prepared(pairs))
    wanted = {f"p_{k}": t for k, t in PROFILE_COLUMNS.items()} | {f"c_{k}": t for k, t in CONSTRAINT_COLUMNS.items()} | {f"p_json_{k}": "string" for k in SHOWN} | dict.fromkeys(BOUNDS, "string")
    have = set(pairs.columns)
    pairs = pairs.withColumns({k: fenced(F.col(k)) for k in pairs.columns if k.startswith(("p_", "c_"))})
    return pairs.withColumns({k: F.lit(None).cast(t) for k, t in wanted.items() if k not in have})


def prepared(records: DataFrame) -> DataFrame:
    """Constraint records with what their texts admit and the JSON of their bounds, made once a record; `evaluate` makes them
    for pairs that lack them.  Columns that they are made of don't change afterwards."""
    readings = {"c_admitted_stages": ("c_stage", stages_admitted), "c_admitted_statuses": ("c_marital_status", marital_admitted)}
    have = set(records.columns)
    made = {k: read(F.col(source)) for k, (source, read) in readings.items() if source in have}
    column = lambda name: F.col(name) if name in have else F.lit(None).cast(CONSTRAINT_COLUMNS[name[2:]])
    for k, parts in BOUNDS.items():
        if have & set(parts.values()):
            made[k] = json_of(**{key: column(name) for key, name in parts.items()})
    return records.withColumns({k: fenced(v) for k, v in made.items() if k not in have})


def stated(profiles: DataFrame) -> DataFrame:
    """Profiles with the JSON of their values, made once a profile; `evaluate` makes it for pairs that lack it."""
    have = set(profiles.columns)
    return profiles.withColumns({f"p_json_{k}": fenced(json_value(F.col(f"p_{k}"))) for k in SHOWN if f"p_{k}" in have and f"p_json_{k}" not in have})


class Conditions:
    """Builds the condition array of one row."""

    def __init__(self, columns: list[str], rules: frozenset[str], wanted: tuple[str, ...] | None = None):
        self.columns, self.rules, self.wanted = set(columns), rules, wanted
        self.fields, self.deciding, self.checks, self.found = [], [], [], []
        facts = F.coalesce(F.col("p_facts"), F.array().cast("array<string>"))
        if "applying_for" in rules:  # M19
            self.other_person = F.coalesce(F.col("p_applying_for").isin(*ON_BEHALF), F.lit(False))
        else:
            cues = F.concat_ws(" ", F.replace(F.col("p_family"), F.lit("_"), F.lit(" ")), F.array_join(facts, " "))
            self.other_person = F.coalesce(cues.rlike(DEPENDENT_WORDS), F.lit(False))
        self.ambiguous = self.other_person | F.coalesce(F.col("c_requires_dependent"), F.lit(False))
        self.whose = F.when(self.other_person, ON_BEHALF_NOTE).when(F.coalesce(F.col("c_requires_dependent"), F.lit(False)), DEPENDENT_NOTE)
        self.prior = (F.size(F.coalesce(F.col("p_prior_benefit_schemes"), F.array().cast("array<string>"))) > 0) | F.exists(facts, lambda x: x.rlike(PRIOR_BENEFIT) & ~x.rlike(NEGATED))

    def usable(self, key: str) -> Column:
        conf = f"p_{key}_conf"
        return usable(F.col(f"p_{key}"), F.col(conf) if conf in self.columns else None)

    def confidence(self, key: str) -> Column:
        conf = f"p_{key}_conf"
        return F.when(F.col(f"p_{key}").isNotNull(), F.col(conf) if conf in self.columns else F.lit("medium"))

    def unusable(self, key: str) -> Column:
        """Why a value can't be used."""
        return F.when(F.col(f"p_{key}").isNull(), "not stated").otherwise(F.concat(self.confidence(key), F.lit(" confidence")))

    def span(self, field: str) -> Column:
        """The scheme's own text for a field: of the map of all spans, or of the field's own column."""
        own = f"c_{field}_span"
        return F.coalesce(F.get(F.map_values(F.map_filter("c_spans", lambda k, _: k == field)), F.lit(0)), F.col(own) if own in self.columns else F.lit(None).cast("string"))

    def add(
        self, field: str, present: Column, result: Column, ask: Column | None = None, kind: Column | None = None, decisive: Column | None = None, gate: bool | Column = False,
        constraint: Column | None = None, value: Column | None = None, key: str | None = None, note: Column | None = None, span: str | None = None,
    ) -> None:
        text = lambda c: F.lit(None).cast("string") if c is None else c
        present, here = F.coalesce(present, F.lit(False)), F.get(F.col(DECIDING), F.lit(len(self.found)))
        self.deciding.append(F.when(present if decisive is None else present & decisive, result))
        if decisive is None:
            result = here
        slim = [
            F.lit(len(self.found) + 1).alias("pos"),
            F.lit(field).alias("field"),
            result.alias("result"),
            (F.lit(True) if decisive is None else decisive).alias("decisive"),
            (F.lit(None).cast("string") if ask is None else F.when(result == "unknown", ask)).alias("ask_field"),
            (F.lit(None).cast("string") if kind is None or ask is None else F.when((result == "unknown") & ask.isNotNull(), kind)).alias("ask_kind"),
            (F.lit(gate) if isinstance(gate, bool) else gate).alias("gate"),
        ]
        details = [
            text(note).alias("note"),
            text(constraint).alias("constraint"),
            (text(value) if value is not None else F.col(f"p_json_{key}") if key else text(None)).alias("profile_value"),
            (self.confidence(key) if key else text(None)).alias("confidence"),
            self.span(span or field).alias("source_span"),
        ]
        self.fields.append((field, gate))
        listed = present if self.wanted is None or field in self.wanted else F.lit(False)
        self.checks.append(F.when(listed, F.struct(*slim).cast(CHECK)))
        self.found.append(F.when(listed, F.struct(*slim, *details).cast(CONDITION)))

    def compared(self, field: str, key: str, present: Column, good: Column, constraint: Column, ambiguous: bool = False, gate: bool = False, span: str | None = None) -> None:
        """Not usable: unknown, ask; ambiguous (the value may be another person's): unknown; else pass or fail."""
        ok = self.usable(key)
        known = F.when(good, "pass").otherwise("fail")
        result = F.when(~ok, "unknown").otherwise(F.when(self.ambiguous, "unknown").otherwise(known) if ambiguous else known)
        note = F.when(~ok, self.unusable(key)).when(self.ambiguous & F.lit(ambiguous), self.whose)
        self.add(field, present, result, F.when(~ok, F.lit(key)), F.lit("missing"), gate=gate, constraint=constraint, key=key, note=note, span=span)

    def arrays(self, df: DataFrame) -> DataFrame:
        """`df` with the deciding results by place, and the arrays of checks and conditions without gaps.

        Results come first and alone, so verdicts need no array of records; arrays that nothing reads are never built.  The
        lists are compiled apart before gaps are taken out, as arguments of functions with lambdas are interpreted, not compiled.
        """
        df = df.withColumn(DECIDING, compiled_apart(F.array(*self.deciding)))
        df = df.withColumns({"__checks": compiled_apart(F.array(*self.checks)), "__conditions": compiled_apart(F.array(*self.found))})
        return df.withColumns({"checks": F.array_compact("__checks"), "conditions": F.array_compact("__conditions")}).drop("__checks", "__conditions")


def income_result(value: Column, cap: Column, basis: Column, scheme_basis: Column) -> Column:
    """M02 for a usable income: equal bases (also both unknown) or a family figure pass under the cap; over it only known, comparable bases fail."""
    under = F.when((basis == "family") | basis.eqNullSafe(scheme_basis), "pass").otherwise("unknown")
    comparable = scheme_basis.isNotNull() & basis.isNotNull() & ((basis == scheme_basis) | ((basis == "individual") & (scheme_basis == "family")))
    return F.when(value <= cap, under).when(comparable, "fail").otherwise("unknown")


def land_result(value: Column, low: Column, high: Column, basis: Column) -> Column:
    """M03 for a usable area."""
    inside = in_range(value, low, high)
    return F.when(inside & ~F.coalesce(basis == "leased", F.lit(False)), "pass").when(~inside & F.coalesce(basis == "owned", F.lit(False)), "fail").otherwise("unknown")


def category_parts(c: Conditions) -> tuple[Column, Column]:
    """For each listed category whether it is known to hold, and the first field that leaves one undetermined."""
    caste, minority, disability = c.usable("caste_category"), c.usable("is_minority"), c.usable("disability_percent") & ~c.other_person

    def one(cat: Column) -> Column:
        known = F.when(cat.isin(*CASTES), F.when(caste, F.col("p_caste_category") == cat)).when(cat == "Minority", F.when(minority, F.col("p_is_minority"))).otherwise(F.when(disability, F.col("p_disability_percent") >= BENCHMARK_DISABILITY))
        return known

    def asked(cat: Column) -> Column:
        return F.when(cat.isin(*CASTES), "caste_category").when(cat == "Minority", "is_minority").otherwise("disability_percent")

    listed = F.coalesce(F.col("c_category"), F.array().cast("array<string>"))
    first_open = F.element_at(F.concat(F.transform(F.filter(listed, lambda x: one(x).isNull()), asked), F.array(F.lit(None).cast("string"))), 1)
    return F.transform(listed, one), first_open


def evaluate(pairs: DataFrame, rules: tuple[str, ...] = RULES, fields: tuple[str, ...] | None = None) -> DataFrame:
    """`pairs` with conditions, checks (their fields up to the gate), preferences, unverified, to_confirm, own_conditions, status,
    reason and personal_pass (M01-M19, A04).

    `rules` are the toggles that apply (U01); an unknown name raises ValueError.  `fields`: those whose conditions the arrays
    list, all by default; verdicts are made of all in any case.
    """
    if unknown := set(rules) - set(RULES):
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    rules = frozenset(rules)
    df = completed(pairs)
    c = Conditions(df.columns, rules, fields)
    col, null_text = F.col, F.array().cast("array<string>")
    true = lambda name: F.coalesce(col(name), F.lit(False))

    c.compared("age", "age", col("c_age_min").isNotNull() | col("c_age_max").isNotNull(), in_range(col("p_age"), col("c_age_min"), col("c_age_max")), col("c_json_age"), True)  # M01
    ok = c.usable("annual_income_inr")
    kind = F.when(~ok, "missing").otherwise("refine")
    c.add("income", col("c_income_cap").isNotNull(), F.when(~ok, "unknown").otherwise(income_result(col("p_annual_income_inr"), col("c_income_cap"), col("p_income_basis"), col("c_income_basis"))), F.when(~ok | col("p_income_basis").isNull(), F.lit("annual_income_inr")), kind, constraint=col("c_json_income"), key="annual_income_inr", note=F.when(~ok, c.unusable("annual_income_inr")))
    ok = c.usable("land_acres")
    kind = F.when(~ok, "missing").otherwise("refine")
    c.add("land", col("c_land_min").isNotNull() | col("c_land_max").isNotNull(), F.when(~ok, "unknown").otherwise(land_result(col("p_land_acres"), col("c_land_min"), col("c_land_max"), col("p_land_basis"))), F.lit("land_acres"), kind, constraint=col("c_json_land"), key="land_acres", note=F.when(~ok, c.unusable("land_acres")))
    c.compared("education_class", "education_class", col("c_class_min").isNotNull() | col("c_class_max").isNotNull(), in_range(col("p_education_class"), col("c_class_min"), col("c_class_max")), col("c_json_class"), span="education")  # M04
    admitted = col("c_admitted_stages")  # M05: no fail, and confidence plays no part
    stage = F.coalesce(col("p_education_stage"), F.when(col("p_education_class") <= 10, "school").when(col("p_education_class") > 10, "higher_secondary"))
    passes = F.coalesce(F.array_contains(admitted, stage), F.lit(False))
    c.add("education_stage", F.coalesce(col("c_stage"), F.lit("")) != "", F.when(passes, "pass").otherwise("unknown"), F.when(admitted.isNotNull(), F.lit("education_stage")), F.when(stage.isNull(), "missing").otherwise("refine"), constraint=json_value(col("c_stage")), value=json_value(stage), span="education")
    c.compared("gender", "gender", col("c_gender") != "any", col("p_gender") == col("c_gender"), json_value(col("c_gender")), True)  # M06

    prefers = {f: is_priority(col(f"c_{f}_span")) & F.lit("priority" in rules) for f in ("category", "occupation")}  # M16
    holds, first_open = category_parts(c)
    can_fail = ~(true("c_multi_branch") & F.lit("multi_branch" in rules))
    some = F.exists(holds, lambda x: F.coalesce(x, F.lit(False)))
    result = F.when(some, "pass").when(first_open.isNotNull() | ~can_fail, "unknown").otherwise("fail")
    shown = F.to_json(F.struct(*[col(f"p_{k}").alias(k) for k in ("caste_category", "is_minority", "disability_percent")]))
    c.add("category", (F.size("c_category") > 0) & ~prefers["category"], result, first_open, F.lit("missing"), constraint=F.to_json("c_category"), value=F.nullif(shown, F.lit("{}")))  # M07
    c.compared("residence", "residence", col("c_residence") != "any", col("p_residence") == col("c_residence"), json_value(col("c_residence")))  # M08
    statuses = col("c_admitted_statuses")  # M09
    ok = c.usable("marital_status")
    result = F.when(statuses.isNull() | ~ok | c.ambiguous, "unknown").when(F.array_contains(statuses, col("p_marital_status")), "pass").otherwise("fail")
    wanted = (F.coalesce(col("c_marital_status"), F.lit("")) != "") & ~F.coalesce(F.array_contains(statuses, "any"), F.lit(False))
    c.add("marital_status", wanted, result, F.when(statuses.isNotNull() & ~ok, F.lit("marital_status")), F.lit("missing"), constraint=json_value(col("c_marital_status")), key="marital_status", note=F.when(statuses.isNotNull() & ~ok, c.unusable("marital_status")).when(statuses.isNotNull() & c.ambiguous, c.whose))
    central = F.coalesce(col("c_level") == "central", F.lit(False))  # M10
    ok = c.usable("state")
    result = F.when(central, "pass").when(~ok, "unknown").when(col("p_state") == col("c_state"), "pass").otherwise("fail")
    place_json = F.when(central, F.lit('"central scheme"')).otherwise(json_value(col("c_state")))
    c.add("state", central | col("c_state").isNotNull(), result, F.when(~central & ~ok, F.lit("state")), F.lit("missing"), constraint=place_json, key="state", note=F.when(central, "central scheme").when(~ok, c.unusable("state")))
    c.compared("bpl_household", "bpl_household", col("c_bpl_household"), col("p_bpl_household"), F.lit("true"))  # M11
    c.compared("registered_construction_worker", "registered_construction_worker", col("c_requires_bocw"), col("p_registered_construction_worker"), F.lit("true"), gate=True, span="requires_bocw_registration")  # M12
    registered = F.lit("bocw_occupation" in rules) & true("c_requires_bocw") & c.usable("registered_construction_worker") & true("p_registered_construction_worker")
    ok = c.usable("occupation")
    similar = F.coalesce(col("p_occupation_similarity") >= OCCUPATION_THRESHOLD, F.lit(False))
    result = F.when(registered | (ok & similar), "pass").otherwise("unknown")  # M13: never fails
    c.add("occupation", (F.size("c_occupation") > 0) & ~prefers["occupation"], result, F.lit("occupation"), F.when(~ok, "missing").otherwise("refine"), gate=registered, constraint=F.to_json("c_occupation"), key="occupation", note=F.when(~registered & ~ok, c.unusable("occupation")))
    c.add("not_availing_other_scheme", col("c_not_availing_other"), F.lit("unknown"), decisive=c.prior, constraint=F.lit("true"), note=F.when(~c.prior, "no prior benefit stated"))  # M14

    residuals = F.coalesce(col("c_residuals"), null_text)
    one = lambda cond, text: F.when(cond, F.array(text)).otherwise(null_text)
    place = F.concat(F.lit("resident of "), col("c_state"), F.lit(" (any domicile rule in the scheme text)"))
    df = c.arrays(df).withColumns(
        {
            "preferences": F.concat(*[one(F.coalesce(prefers[f] & (F.size(f"c_{f}") > 0), F.lit(False)), F.lit(f)) for f in prefers]),
            "unverified": F.concat(one(F.coalesce(col("c_family_notes"), F.lit("")) != "", col("c_family_notes")), one(true("c_requires_dependent"), F.lit("the scheme requires a dependent (see the scheme text)")), residuals),  # M17
            "to_confirm": F.concat(one(~central & col("c_state").isNotNull(), place), one(true("c_citizen"), F.lit("citizen of India"))),  # M15
        }
    )
    return verdict(df, c.fields, rules).drop(DECIDING)


def verdict(df: DataFrame, fields: list[tuple[str, bool | Column]], rules: frozenset[str] = frozenset(RULES)) -> DataFrame:
    """Fail > unknown > pass over decisive conditions, then the rules that can only lower it.

    fields: name and gate of each place of the deciding results.  personal_pass: whether one passes that is neither the place nor a gate.
    """
    places = [(name, gate, F.get(F.col(DECIDING), F.lit(k))) for k, (name, gate) in enumerate(fields)]
    named = lambda result: F.concat_ws(", ", *[F.when(r == result, name) for name, _, r in places])
    has = lambda result: F.coalesce(F.array_contains(DECIDING, result), F.lit(False))
    some = lambda tests: F.coalesce(reduce(or_, tests, F.lit(False)), F.lit(False))
    passing = [(gate, F.coalesce(r == "pass", F.lit(False))) for name, gate, r in places if name != "state"]
    personal = some([p for _, p in passing])
    own_pass = some([p & ~(F.lit(gate) if isinstance(gate, bool) else F.coalesce(gate, F.lit(False))) for gate, p in passing])
    residuals = F.coalesce(F.col("c_residuals"), F.array().cast("array<string>")) if "c_residuals" in df.columns else F.array().cast("array<string>")
    missing = F.coalesce(F.col("c_missing"), F.lit(False)) if "c_missing" in df.columns else F.lit(False)
    touched = F.lit("residual_touch" in rules) & ((F.coalesce(F.col("c_touches"), F.lit(0)) > 0) if "c_touches" in df.columns else F.lit(False))
    nobody = F.lit("person_level_pass" in rules) & ~personal
    gated = F.lit("bocw_gate" in rules) & personal & ~own_pass & (F.size(residuals) > 0)
    reason = (
        F.when(missing, "no constraint record")
        .when(has("fail"), F.concat(F.lit("a condition fails: "), named("fail")))
        .when(has("unknown"), F.concat(F.lit("could not check: "), named("unknown")))
        .when(nobody, "nothing about you could be checked automatically")
        .when(gated, "You're registered, but this scheme's own conditions must be confirmed")
        .when(touched, "something you said may bear on a condition that is not checked automatically")
        .otherwise("every checked condition passes")
    )
    status = F.when(missing, "needs_checking").when(has("fail"), "not_eligible").when(has("unknown") | nobody | gated | touched, "needs_checking").otherwise("eligible")
    own = F.when(~missing & ~has("fail") & ~has("unknown") & ~nobody & gated, residuals).otherwise(F.array().cast("array<string>"))
    return df.withColumns({"status": status, "reason": compiled_apart(reason), "own_conditions": own, "typed_condition_count": reduce(add, [F.when(r.isNotNull(), 1).otherwise(0) for _, _, r in places]), "personal_pass": own_pass})


def condition_rows(evaluated: DataFrame, keys: tuple[str, ...], details: bool = True) -> DataFrame:
    """One row per condition: keys and the fields of a condition; without details those that checks have, which are made much sooner."""
    more = ("note", "constraint", "profile_value", "confidence", "source_span") if details else ()
    rows = evaluated.select(*keys, F.explode("conditions" if details else "checks").alias("x"))
    return rows.select(*keys, *[f"x.{f}" for f in ("pos", "field", "result", "decisive", "ask_field", "ask_kind", "gate", *more)])


def blocking_fields(evaluated: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """For each field that a question could settle, the kind of the first condition that asks for it."""
    checks = "checks" if "checks" in evaluated.columns else "conditions"
    rows = evaluated.select(*keys, F.explode(checks).alias("x")).filter("x.decisive and x.result = 'unknown' and x.ask_field is not null")
    rows = rows.select(*keys, "x.pos", "x.ask_field", "x.ask_kind")
    return rows.groupBy(*keys, "ask_field").agg(F.min_by("ask_kind", "pos").alias("ask_kind"))


def clarifying_field(evaluated: DataFrame, query: str = "query_id", slug: str = "slug", rank: str = "rnk", top: int = 10, least: float = CLARIFY_SCORE) -> DataFrame:
    """Per query the field that blocks most of the top candidates not ruled out, weighted by 1/rank; ties go to the
    first name; below the least score there is no question (field null)."""
    live = evaluated.filter((F.col(rank) <= top) & (F.col("status") != "not_eligible"))
    blocks = blocking_fields(live, (query, slug, rank))
    scored = blocks.groupBy(query, "ask_field").agg(
        F.sum(1.0 / F.col(rank)).alias("score"), F.max((F.col("ask_kind") == "refine").cast("int")).alias("refine"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(slug).alias("s")))), lambda x: x["s"].cast("string")), ",").alias("blocks")
    )
    order = W.partitionBy(query).orderBy(F.desc(F.round("score", 9)), "ask_field")
    best = scored.withColumn("n", F.row_number().over(order)).filter("n = 1")
    return best.select(query, F.when(F.round("score", 9) >= least, F.col("ask_field")).alias("field"), F.when(F.col("refine") == 1, "refine").otherwise("missing").alias("kind"), F.round("score", 4).alias("score"), "blocks")


def occupation_similarity(pairs: DataFrame, vectors: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys, best listed occupation and its cosine with the profile's.  `vectors`: (text, vector) of distinct texts."""
    listed = pairs.select(*keys, "p_occupation", F.explode("c_occupation").alias("listed"))
    mine = vectors.select(F.col("text").alias("p_occupation"), F.col("vector").alias("__a"))
    theirs = vectors.select(F.col("text").alias("listed"), F.col("vector").alias("__b"))
    rows = listed.join(mine, "p_occupation").join(theirs, "listed").withColumn("sim", dot(F.col("__a"), F.col("__b")))
    best = rows.groupBy(*keys).agg(F.max(F.struct("sim", "listed")).alias("b"))
    return best.select(*keys, F.col("b.listed").alias("best"), F.col("b.sim").alias("p_occupation_similarity"))


def residual_touches(facts: DataFrame, residuals: DataFrame, vectors: DataFrame, least: float = TOUCH_THRESHOLD) -> DataFrame:
    """(query_id, slug, fact, residual, similarity) for candidates' residuals near a stated fact.

    facts: (query_id, fact); residuals: (query_id, slug, residual) of candidates only, so the pairs are
    bounded by facts per query times residuals per candidate.
    """
    a = facts.join(vectors.select(F.col("text").alias("fact"), F.col("vector").alias("__a")), "fact")
    b = residuals.join(vectors.select(F.col("text").alias("residual"), F.col("vector").alias("__b")), "residual")
    rows = a.join(b, "query_id").withColumn("similarity", F.round(dot(F.col("__a"), F.col("__b")), 4))
    return rows.filter(F.col("similarity") >= least).select("query_id", "slug", "fact", "residual", "similarity")
