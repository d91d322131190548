"""After the matcher: residual classes, caveats, downgrades, reasons and display order.

Every step can only lower ``eligible`` to ``needs_checking``; nothing is raised and nothing becomes ``not_eligible``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligspark.functions import wording as T
from eligspark.functions.rules import NUMERIC_KINDS, SUBJECTS, confident, constraint_numbers, marital_admitted, satisfies, stated_bound
from eligspark.functions.text import denials, digit_numbers, indian_grouping, is_grounded, is_requirement, let, number_text, plain_norm, quotable, unhedged_claims
from eligspark.operators.corpus import containing
from eligspark.schemas import CASTES

# Display order of the statuses, and the note that stands apart from the unverified conditions.
STATUS_ORDER = {"eligible": 0, "needs_checking": 1, "not_eligible": 2}
DEPENDENT_NOTE = "the scheme requires a dependent (see the scheme text)"
#: The central scheme's place as a condition's constraint.
EVERYWHERE = '"central scheme"'


def passed(conditions: Column) -> Column:
    return F.filter(conditions, lambda c: c["decisive"] & (c["result"] == "pass"))


def classify_residual(residual: Column, conditions: Column) -> Column:
    """struct(kind, field).  conditions: array of struct(field, result, decisive, constraint JSON, source_span), in order.

    A residual that equals a clause of a passed check is its restatement; one about the same quantity with a number
    that the check didn't use is stricter; the first condition that applies counts; anything else is other.
    """

    def restates(c: Column, norm: Column) -> Column:
        clauses = F.transform(F.split(F.coalesce(c["source_span"], F.lit("")), r" \| "), lambda x: plain_norm(x))
        return (norm != "") & (F.coalesce(c["source_span"], F.lit("")) != "") & F.array_contains(clauses, norm)

    def stricter(c: Column, numbers: Column) -> Column:
        about = F.lit(False)
        for field, pattern in SUBJECTS.items():
            about = about | ((c["field"] == field) & residual.rlike(pattern))
        allowed = constraint_numbers(F.coalesce(c["constraint"], F.lit("")))
        return about & let(allowed, lambda known: ~F.forall(numbers, lambda n: F.exists(known, lambda a: F.abs(n - a) < 0.01)))

    def judged(own: Column) -> Column:
        first = lambda test: F.get(F.filter(own["good"], test), F.lit(0))["field"]
        found = F.struct(first(lambda c: restates(c, own["norm"])).alias("a"), first(lambda c: stricter(c, own["numbers"])).alias("b"))
        kind = lambda f: F.when(f["a"].isNotNull(), "restatement").when(f["b"].isNotNull(), "stricter").otherwise("other")
        return let(found, lambda f: F.struct(kind(f).alias("kind"), F.coalesce(f["a"], f["b"]).alias("field")))

    return let(F.struct(passed(conditions).alias("good"), plain_norm(residual).alias("norm"), digit_numbers(residual).alias("numbers")), judged)


def within(value: Column):
    """Whether the value meets a bound, as a function of the bound."""
    return lambda bound: bound.isNotNull() & F.coalesce(satisfies(value, bound), F.lit(False))


def is_settled(residual: Column, field: Column, values: dict[str, Column], confidences: dict[str, Column] | None) -> Column:
    """The person's own confident value meets the bound that the residual states."""
    out = F.lit(False)
    for name, key in NUMERIC_KINDS.items():
        if key in values:
            sure = confident(values[key], None if confidences is None else confidences.get(key, F.lit(None).cast("string")))
            out = F.when(field == name, sure & let(stated_bound(residual, key), within(values[key]))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def caveats(residuals: Column, conditions: Column, values: dict[str, Column], confidences: dict[str, Column] | None) -> Column:
    """struct(shown array<string>, trigger struct(residual, field)): requirements that nothing has checked, in order, and
    the first of them that is a stricter bound which the person's answers don't settle."""
    judged = F.transform(F.filter(residuals, is_requirement), lambda r: F.struct(r.alias("residual"), classify_residual(r, conditions).alias("class")))
    judged = F.filter(judged, lambda x: (x["class"]["kind"] != "restatement") & ~((x["class"]["kind"] == "stricter") & is_settled(x["residual"], x["class"]["field"], values, confidences)))

    def put(kept: Column) -> Column:
        first = let(F.get(F.filter(kept, lambda x: x["class"]["kind"] == "stricter"), F.lit(0)), lambda t: F.struct(t["residual"].alias("residual"), t["class"]["field"].alias("field")))
        return F.struct(F.transform(kept, lambda x: x["residual"]).alias("shown"), first.alias("trigger"))

    return let(judged, put)


def count_sentence(n: Column, lang: Column | None = None, other: bool = False) -> Column:
    """How many conditions (or other conditions) are still to confirm, in the language."""
    lang = F.lit("en") if lang is None else T.language(lang)
    noun = T.worded({k: v[1] for k, v in T.NOUN.items()}, lang)
    noun = F.when(n == 1, T.worded({k: v[0] for k, v in T.NOUN.items()}, lang)).otherwise(noun)
    return T.worded(T.COUNT_OTHER if other else T.COUNT, lang, n=n, noun=noun)


def as_sentence(quote: Column) -> Column:
    return F.when(quote.rlike("[.…।?!]$"), quote).otherwise(F.concat(quote, F.lit(".")))


def value_text(key: str, value: Column) -> Column:
    return indian_grouping(value) if key == "annual_income_inr" else number_text(value)


def shown_label(condition: Column, lang: Column) -> Column:
    """A checked condition with the value that it was checked with."""
    label, value = T.named(T.FIELDS, condition["field"], lang), condition["profile_value"]
    number = F.when(value.rlike("^[-0-9]"), value.try_cast("double"))  # other texts would each raise an exception inside the cast
    word = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    written = lambda n: F.when(n.isNotNull(), F.when(condition["field"] == "income", F.concat(F.lit("₹"), indian_grouping(n))).otherwise(number_text(n))).when(value.startswith('"'), word)
    return let(let(number, written), lambda text: F.when(text.isNotNull(), F.concat(label, F.lit(" ("), text, F.lit(")"))).otherwise(label))


def checked_labels(conditions: Column, lang: Column) -> Column:
    """Labels of what passed; a scheme for the whole country has checked no place."""
    own = F.filter(passed(conditions), lambda c: ~((c["field"] == "state") & c["constraint"].eqNullSafe(F.lit(EVERYWHERE))))
    return F.transform(own, lambda c: shown_label(c, lang))


def downgrade_reason(trigger: Column, conditions: Column, values: dict[str, Column], confidences: dict[str, Column] | None, others: Column, source: Column, lang: Column) -> Column:
    """Names the stricter condition, quoted where the scheme's own text has it, with the person's confident value where
    given; then what else was checked and how many conditions are left."""
    quote, label = quotable(trigger["residual"]), T.named(T.TRIGGER_LABEL, trigger["field"], lang)
    said = F.lit(None).cast("string")
    for field, key in NUMERIC_KINDS.items():
        if key in values:
            sure = confident(values[key], None if confidences is None else confidences.get(key, F.lit(None).cast("string")))
            said = F.when((trigger["field"] == field) & sure, T.worded(T.of(T.SAID_VALUE, key), lang, v=value_text(key, values[key]))).otherwise(said)
    grounded = is_grounded(quote, source)
    first = (
        F.when(said.isNotNull() & grounded, T.worded(T.OWN_TEXT, lang, said=said, quote=as_sentence(quote)))
        .when(said.isNotNull(), T.worded(T.OWN_TEXT_UNQUOTED, lang, said=said, label=label))
        .when(grounded, T.worded(T.REQUIRES, lang, quote=as_sentence(quote)))
        .otherwise(T.worded(T.REQUIRES_UNQUOTED, lang, label=label))
    )
    rest = T.joined(checked_labels(F.filter(conditions, lambda c: c["field"] != trigger["field"]), lang), lang)
    return F.concat_ws(" ", first, let(rest, lambda r: F.when(r != "", T.worded(T.CHECKED, lang, passed=r))), F.when(others > 0, count_sentence(others, lang, other=True)))


def finalize(df: DataFrame, values: dict[str, Column], confidences: dict[str, Column] | None, source: Column, lang: Column | None = None) -> DataFrame:
    """`df` (status, reason, unverified, conditions as the matcher makes them) with caveats, final_status, final_reason.

    Ruled-out candidates get no caveats; an eligible one with a trigger is lowered; other reasons get the caveat count.
    `source` is the scheme's own text; quotes may also stand in the unverified conditions themselves.
    """
    lang = F.lit("en") if lang is None else T.language(lang)
    live = F.col("status") != "not_eligible"
    df = df.withColumn("__c", F.when(live, caveats(F.col("unverified"), F.col("conditions"), values, confidences)))
    shown = F.coalesce(F.col("__c.shown"), F.array().cast("array<string>"))
    lowered = (F.col("status") == "eligible") & F.col("__c.trigger.residual").isNotNull()
    counted = F.when(F.size(shown) > 0, F.concat_ws(" ", F.col("reason"), count_sentence(F.size(shown), lang))).otherwise(F.col("reason"))
    sources = F.concat_ws("\u0001", F.array_join("unverified", "\u0001"), source)
    why = downgrade_reason(F.col("__c.trigger"), F.col("conditions"), values, confidences, F.size(shown) - 1, sources, lang)
    return df.withColumns({"caveats": shown, "final_status": F.when(lowered, "needs_checking").otherwise(F.col("status")), "final_reason": F.when(lowered, why).otherwise(counted)}).drop("__c")


def display_order(df: DataFrame, status: str = "status", rank: str = "rnk") -> list[Column]:
    """Sort columns: status group, candidates with a personal pass first (place and board registration are none), retrieval rank."""
    group = F.lit(len(STATUS_ORDER))
    for name, n in STATUS_ORDER.items():
        group = F.when(F.col(status) == name, n).otherwise(group)
    personal = F.col("personal_pass") if "personal_pass" in df.columns else F.exists("conditions", lambda c: c["decisive"] & (c["result"] == "pass") & (c["field"] != "state") & ~F.coalesce(c["gate"], F.lit(False)))
    return [group, F.when(personal, 0).otherwise(1), F.col(rank)]


def part(constraint: Column, key: str) -> Column:
    return F.get_json_object(constraint, f"$.{key}")


def bounds_rule(kind: str, low: Column, high: Column, lang: Column, exact: str | None = None) -> Column:
    """The rule of a range, open or closed."""
    rule = F.when(high.isNull(), T.worded(T.of(T.RULE, f"{kind}_min"), lang, lo=low)).when(low.isNull(), T.worded(T.of(T.RULE, f"{kind}_max"), lang, hi=high))
    rule = rule.otherwise(T.worded(T.of(T.RULE, f"{kind}_range"), lang, lo=low, hi=high))
    return rule if exact is None else F.when(low == high, T.worded(T.of(T.RULE, exact), lang, lo=low)).otherwise(rule)


def failed_sentence(c: Column, lang: Column) -> Column:
    """What the scheme demands and what the person said, for one failed condition."""
    con, value = c["constraint"], c["profile_value"]
    number = lambda key: let(part(con, key), lambda p: F.when(p.isNotNull(), number_text(p.try_cast("double"))))
    bounds = lambda kind, low, high, exact=None: let(F.struct(number(low).alias("low"), number(high).alias("high")), lambda b: bounds_rule(kind, b["low"], b["high"], lang, exact))
    scalar = lambda x: F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v")
    rule, said = (lambda key, **v: T.worded(T.of(T.RULE, key), lang, **v)), (lambda key, **v: T.worded(T.of(T.SAID, key), lang, **v))
    v, w = let(value.try_cast("double"), number_text), scalar(value)
    family = F.when(part(con, "basis") == "family", T.worded(T.FAMILY, lang))
    listed = F.from_json(con, "array<string>")
    categories = T.joined(F.transform(listed, lambda x: T.named(T.CATEGORY, x, lang)), lang, T.OR)
    told = F.array(
        F.when(part(value, "caste_category").isNotNull() & F.exists(listed, lambda x: x.isin(*CASTES)), said("caste", v=part(value, "caste_category"))),
        F.when((part(value, "is_minority") == "false") & F.array_contains(listed, "Minority"), said("minority")),
        F.when(part(value, "disability_percent").isNotNull() & F.array_contains(listed, "PwD"), said("disability", v=number_text(part(value, "disability_percent").try_cast("double")))),
    )
    admitted = marital_admitted(scalar(con))
    statuses = F.coalesce(T.joined(F.transform(F.array_sort(admitted), lambda x: T.named(T.MARITAL, x, lang)), lang, T.OR), scalar(con))
    table = {
        "age": (bounds("age", "min", "max", "age_exact"), said("age", v=v)),
        "income": (rule("income", basis=family, cap=let(part(con, "max_annual_inr").try_cast("double"), indian_grouping)), said("income", v=let(value.try_cast("double"), indian_grouping))),
        "land": (bounds("land", "min_acres", "max_acres"), said("land", v=v)),
        "education_class": (bounds("class", "min_class", "max_class"), said("education_class", v=v)),
        "gender": (rule("gender", g=T.named(T.GENDERS, scalar(con), lang)), said("gender", g=T.named(T.GENDER, w, lang))),
        "category": (rule("category", cats=categories), T.joined(told, lang)),
        "residence": (rule("residence", r=T.named(T.RESIDENCE, scalar(con), lang)), said("residence", r=T.named(T.RESIDENCE, w, lang))),
        "marital_status": (rule("marital_status", ms=statuses), said("marital_status", ms=T.named(T.MARITAL, w, lang))),
        "state": (rule("state", state=scalar(con)), said("state", v=w)),
        "bpl_household": (rule("bpl_household"), said("bpl_household")),
        "registered_construction_worker": (rule("registered_construction_worker"), said("registered_construction_worker")),
    }
    out = F.lit(None).cast("string")
    for field, (demand, answer) in table.items():
        sentence = F.concat(demand, let(answer, lambda a: F.when(a != "", F.concat(F.lit("; "), a)).otherwise("")), T.worded(T.STOP, lang))
        out = F.when(c["field"] == field, sentence).otherwise(out)
    return out


def failed_reason(conditions: Column, lang: Column | None = None) -> Column:
    """Sentences for the failed decisive conditions, in order."""
    lang = F.lit("en") if lang is None else T.language(lang)
    failed = F.filter(conditions, lambda c: c["decisive"] & (c["result"] == "fail"))
    return F.array_join(F.transform(failed, lambda c: failed_sentence(c, lang)), " ")


def fallback_reason(conditions: Column, status: Column, lang: Column | None = None, unchecked: Column | None = None, clause: Column | None = None) -> Column:
    """The template reason: what was checked, what is still to confirm, and the scheme's first clause (up to 200 characters).

    `unchecked`: whether the scheme has conditions of its own that nothing has checked.
    """
    lang = F.lit("en") if lang is None else T.language(lang)
    fields = F.transform(F.filter(conditions, lambda c: c["decisive"] & (c["result"] == "unknown")), lambda c: c["field"])
    more = F.lit(False) if unchecked is None else F.coalesce(unchecked, F.lit(False))
    fields = let(fields, lambda f: F.array_distinct(F.when(more | (F.size(f) == 0), F.concat(f, F.array(F.lit("other")))).otherwise(f)))
    pending = T.joined(F.transform(fields, lambda f: T.named(T.FIELDS, f, lang)), lang)
    kind = lambda name, **v: T.worded(T.of(T.TEMPLATE, name), lang, **v)
    put = lambda checked: F.when(status == "eligible", kind("eligible", passed=checked)).otherwise(let(pending, lambda p: F.when(checked != "", kind("partly", passed=checked, pending=p)).otherwise(kind("nothing", pending=p))))
    text = let(T.joined(checked_labels(conditions, lang), lang), put)
    if clause is not None:
        short = F.when(F.length(clause) <= 200, clause).otherwise(F.concat(F.rtrim(F.left(clause, F.lit(200))), F.lit("…")))
        text = F.concat(text, F.when(clause.isNotNull(), T.worded(T.of(T.TEMPLATE, "clause"), lang, clause=short)).otherwise(""))
    return F.when(status == "not_eligible", failed_reason(conditions, lang)).otherwise(text)


def with_explanations(rows: DataFrame, explanations: DataFrame) -> DataFrame:
    """`rows` (query_id, slug, status, template) with reason, citations and status of their explanation
    (query_id, slug, status, reason, citations), where there is one; else the template reason and the matcher's status."""
    given = explanations.select("query_id", "slug", F.col("status").alias("__status"), F.col("reason").alias("__reason"), F.col("citations").alias("__citations"))
    out = rows.drop("citations").join(given, ["query_id", "slug"], "left")
    return out.withColumns({"status": F.coalesce("__status", "status"), "reason": F.coalesce("__reason", "template"), "citations": F.col("__citations")}).drop("__status", "__reason", "__citations")


def span_citations(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """(slug, span, chunk_id): the first of the scheme's chunks that contains the span word for word.  spans: (slug, span); chunks: (slug, chunk_id, raw_text, pos)."""
    wanted = spans.filter(F.coalesce("span", F.lit("")) != "").select(F.struct("slug", "span").alias("s"), F.col("span").alias("text")).distinct()
    found = containing(chunks.select(F.struct("slug", "pos", "chunk_id").alias("c"), F.col("raw_text").alias("text")), wanted, "c", "s").filter("c.slug = s.slug")
    return found.groupBy(F.col("s.slug").alias("slug"), F.col("s.span").alias("span")).agg(F.min(F.struct("c.pos", "c.chunk_id")).alias("first")).select("slug", "span", "first.chunk_id")


def relevance_flags(flags: DataFrame, facts: DataFrame, residuals: DataFrame, checked: DataFrame) -> DataFrame:
    """(query_id, slug, residual_id, fact_id) pairs that exist and whose fact no condition has checked; any of them lowers an eligible candidate."""
    known = flags.join(facts, ["query_id", "fact_id"]).join(residuals.select("query_id", "slug", "residual_id"), ["query_id", "slug", "residual_id"])
    return known.join(checked, ["query_id", "fact_id"], "left_anti").select("query_id", "slug", "residual_id", "fact_id").distinct()


def lowered_by_flags(df: DataFrame, flags: DataFrame) -> DataFrame:
    """Eligible candidates with a flag become needs_checking."""
    hit = flags.select("query_id", "slug").distinct().withColumn("__hit", F.lit(True))
    out = df.join(hit, ["query_id", "slug"], "left")
    return out.withColumn("status", F.when((F.col("status") == "eligible") & F.col("__hit"), "needs_checking").otherwise(F.col("status"))).drop("__hit")


def citation_errors(quote: Column, chunk: Column, same_scheme: Column, least: int = 12) -> Column:
    """What is wrong with a citation: another scheme's chunk, no exact part of it, or too short; an empty list if it is valid."""
    quote_, chunk_ = F.coalesce(quote, F.lit("")), F.coalesce(chunk, F.lit(""))
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(same_scheme, F.lit(False)), "chunk of another scheme"),
            F.when((quote_ == "") | ~F.contains(chunk_, quote_), "not a part of the chunk"),
            F.when(F.length(quote_) < F.least(F.lit(least), F.length(chunk_)), "too short"),
        )
    )


def reason_errors(reason: Column, status: Column, allowed_numbers: Column, facts: Column, lang: Column | None = None, known_places: Column | None = None, places: tuple[str, ...] = (), most_sentences: int = 2) -> Column:
    """What is wrong with a generated reason: script and length, a claim that the status doesn't bear out or a denial of
    an eligible result, numbers that nothing supports, relatives that no fact names, and places that are nowhere known."""
    from eligspark.functions.text import INDIC, SCRIPTS, derivable, sentence_count, unsupported_relatives

    lang = F.lit("en") if lang is None else lang
    loose = F.filter(digit_numbers(reason), lambda n: ~derivable(n, allowed_numbers))
    wrong_script = F.when(lang == "en", reason.rlike(INDIC))
    for code, script in SCRIPTS.items():
        wrong_script = wrong_script.when(lang == code, ~reason.rlike(script))
    named = F.filter(F.array(*[F.lit(p) for p in places]).cast("array<string>"), lambda p: F.contains(F.lower(reason), F.lower(p)) & ~F.array_contains(F.coalesce(known_places, F.array().cast("array<string>")), p)) if known_places is not None else None
    blank = F.trim(F.coalesce(reason, F.lit(""))) == ""
    return F.array_compact(
        F.array(
            F.when(blank, "empty"),
            F.when(~blank & wrong_script, "wrong script"),
            F.when(sentence_count(reason) > most_sentences, "too many sentences"),
            F.when((status != "eligible") & (F.size(unhedged_claims(reason, T.language(lang))) > 0), "claims eligibility"),
            F.when((status == "eligible") & denials(reason, T.language(lang)), "denies eligibility"),
            F.when(F.size(loose) > 0, "number without support"),
            F.when(F.size(unsupported_relatives(reason, facts, lang)) > 0, "relative without support"),
            F.lit(None).cast("string") if named is None else F.when(F.size(named) > 0, "place without support"),
        )
    )


def verbatim_flags(conditions: Column, source: Column) -> Column:
    """For each shown condition whether it stands word for word in the source."""
    return F.transform(conditions, lambda c: F.contains(source, c))


def without_dependent_note(unverified: Column) -> Column:
    """struct(unverified, requires_dependent): the note about a dependent stands apart."""
    return F.struct(F.array_remove(unverified, DEPENDENT_NOTE).alias("unverified"), F.array_contains(unverified, DEPENDENT_NOTE).alias("requires_dependent"))


def clarified_text(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """The user's turns of a conversation in order, joined by spaces, and how many there are."""
    mine = turns.filter("role = 'user'").groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return mine.select(conversation, F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("query"), F.size("t").cast("long").alias("n_turns"))


def also_noted(unverified: Column, shown: Column) -> Column:
    """What is unverified and not already shown, order kept, each once."""
    return F.array_except(F.array_distinct(unverified), shown)
